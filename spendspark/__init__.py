"""spendspark: expense-claim analytics as Spark jobs."""
