"""Multi-operator jobs: reports, sinks, the end-to-end run."""
