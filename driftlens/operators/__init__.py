"""DataFrame operators: series, detection, lifecycles, rules, mining, traces and alerts."""
