"""Streaming: the analysed programs read every input once as a batch file; they
have no watermark, window, state or late-data rule, so no streaming operator
is built. Every operator here is a DataFrame -> DataFrame function and can be
applied to each micro-batch through ``foreachBatch`` if a stream is needed.
"""
