"""File formats, landing folders, audited loads and versioned RAW tables."""
