"""Plans of several jobs: graph iterations and validation."""
