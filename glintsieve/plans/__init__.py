"""The registered queries over the driver's tables, and logs made from those tables."""
