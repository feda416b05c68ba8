"""One query per corpus operator, over whole tables."""

from assaykit.llm import bytepairs, chat, crf, jaccard, licenses, merkle, mixing, packing, pii, prefix_trie, recipes, syncmers, warc

MODULES = (syncmers, licenses, crf, pii, recipes, chat, jaccard, mixing, packing, warc, prefix_trie, merkle, bytepairs)
QUERIES = {m.QUERY: m.query for m in MODULES}
ORACLES = {m.QUERY: m.SQL for m in MODULES if m.SQL}
