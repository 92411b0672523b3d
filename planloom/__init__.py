"""planloom: Spark-native operators for collections of plans, outcomes and texts."""
