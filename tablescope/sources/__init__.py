"""Reading CSV files and writing result bundles."""
