"""Every operator as a query over the given tables, with its SQL twin."""
