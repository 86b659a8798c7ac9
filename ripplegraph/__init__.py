"""Change-impact analytics on Spark: what can this change break, and which tests show it?"""
