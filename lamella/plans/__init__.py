"""Plans built from models: reading one version of a record with another."""
