"""filelake: a PySpark-native engine for cataloguing and processing file collections."""
