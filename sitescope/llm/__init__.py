"""Operators for building training corpora, and the queries that apply them.

bpe          byte-level BPE by merge replay over a block's distinct pieces
line_dedup   three-line windows, later occurrences removed (native)
chat         conversations to one marked string, by columnar byte assembly
packing      tokenised documents into full sequences by swap search
suffix_dedup repeated passages by sparse suffix arrays
ann          nearest vectors by adaptive dimension scans of probed lists
quality      rule cascade ordered by rejection per cost (native)
toxicity     subword-bag embeddings with a linear softmax
langid       nearest clustered centroid over TF-IDF n-grams
simhash      SimHash classes by pigeonring candidate chains
resample     importance resampling towards a target, cut by medians of medians
debruijn     substrings of 13 words removed by De Bruijn compaction
search       ranked lexical search over bit-sliced Bloom signatures
"""
