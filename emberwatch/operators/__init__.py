"""DataFrame-to-DataFrame operators: windows, detectors, rules, correlation."""
