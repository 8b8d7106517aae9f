"""Subscription-mail analytics and corpus preparation as Spark jobs."""
