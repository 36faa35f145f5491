"""quarry: top-k high-utility itemset mining expressed as Spark plans."""
