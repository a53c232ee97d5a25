"""tallyloom: Spark-native analytics over agent-rollout logs and training corpora."""

__version__ = "0.1.0"
