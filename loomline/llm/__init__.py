"""Training-data operators over documents and pages.

Every operator is a Spark job. Nothing outside this subpackage imports it.
"""
