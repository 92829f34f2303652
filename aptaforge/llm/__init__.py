"""Training-data operators: ten DataFrame-to-DataFrame operators for web-scale text corpora.

Nothing outside this folder imports it; its queries are in ``aptaforge.llm.catalog``.
"""
