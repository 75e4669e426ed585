"""Set-at-a-time operators over DataFrames."""
