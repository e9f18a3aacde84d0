"""Training-data operators: quality, decontamination, toxicity, archives, near duplicates,
substring duplicates, URL rules, chat formatting, secret scans and packing."""
