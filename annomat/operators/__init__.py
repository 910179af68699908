"""Matrix, column, codec and metadata operators over DataFrames."""
