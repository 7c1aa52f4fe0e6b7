"""The driver's tables read as property markets, the registered queries, and their SQL."""
