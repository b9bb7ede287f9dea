"""Product-catalogue analytics on Spark DataFrames.

Every public function takes DataFrames and returns a DataFrame; the caller owns
the session, the connection options and the choice of sink.
"""
