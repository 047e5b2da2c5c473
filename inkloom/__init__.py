"""inkloom: a PySpark-native engine for archives of letters that were read several times."""
