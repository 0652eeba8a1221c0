"""Reading entity tables and writing matrices, predictions and exports."""
