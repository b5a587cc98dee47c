"""Engagement analytics on Spark: timelines, states, topics and forecasts of posts in online communities."""
