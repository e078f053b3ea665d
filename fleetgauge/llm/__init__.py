"""Operators that prepare training text at corpus scale.

warc           archives of web records, written and read in byte ranges
linededup      lines repeated between documents
neardup        near copies by MinHash and connected components
chat           chat templates at token level, with loss masks
pieces         SentencePiece ids by distinct chunks
langid         language by compressed size
decontam       passages of benchmark items
quality        learned decision lists over text statistics
toxicity       misspelling-tolerant lexicon with context scores
tokencount     tokens attributed to sections
queries        the registered queries and their SQL

Nothing outside this package imports it.
"""
