"""End-to-end jobs: training, batch scoring, uploads."""
