"""Readers: snapshot folders, test reports, coverage reports, policy files, driver tables."""
