"""tagloom: register filling, document search and bulk text preparation as PySpark DataFrame operators."""
