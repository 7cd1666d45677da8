"""umbra: a Spark-native engine that sanitises and analyses configuration text."""
