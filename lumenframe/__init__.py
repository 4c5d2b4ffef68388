"""A Spark-native engine with the breadth of a labelled, ordered dataframe interface."""
