"""Conversation-graph analytics on Spark."""
