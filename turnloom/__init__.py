"""Analytics over timed, speaker-labelled event data, built on Spark DataFrames."""
