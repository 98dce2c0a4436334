"""tidewake: a PySpark-native engine for monitoring streams, sessions, archives and corpora."""
