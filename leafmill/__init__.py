"""leafmill: a PySpark-native analytics engine for collections of study documents."""
