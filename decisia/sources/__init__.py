"""Scans, sinks and what stands beside them: manifests, fingerprints, key tables."""
