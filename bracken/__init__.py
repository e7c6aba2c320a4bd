"""Model-artifact inventories and corpus operators on Spark. `bracken.operators.scans` has scan, diff and scorecard."""
