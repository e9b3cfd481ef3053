"""Operators for training-data pipelines. Nothing else in the library imports this subpackage.

``doc_id``, ``page_id`` and ``vec_id`` are whole numbers, or text that reads as one, unless
an operator says otherwise; text that is no number raises.
"""
