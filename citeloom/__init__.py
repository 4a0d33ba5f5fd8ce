"""citeloom: entity resolution and text preparation for bibliographic data on PySpark."""
