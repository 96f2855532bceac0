"""STAGING transforms, marts, reports, quality checks, policies and mart refresh."""
