"""Multi-step jobs: features, models, diagnostics, the whole pipeline."""
