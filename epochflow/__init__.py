"""Signal-decoding analytics on Spark DataFrames: windows, epochs, screening, features, models, decisions."""
