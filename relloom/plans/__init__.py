"""Feature synthesis: which features to make, and the DataFrames that compute them."""
