"""Quire: a PySpark-native engine for segmenting and analysing collections of plain-text books."""
