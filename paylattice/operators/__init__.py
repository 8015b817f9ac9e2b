"""Table-level jobs: functions from DataFrames to DataFrames."""
