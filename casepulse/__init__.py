"""casepulse: client-activity, service-level and churn analytics as Spark DataFrame operators."""
