"""Multi-operator jobs: the scan, the reports and the payload tables."""
