"""Reading facts and signals, staging intermediates, writing the warehouse."""
