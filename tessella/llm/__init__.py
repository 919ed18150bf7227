"""Training-data operators: quality, secrets, search, near duplicates, language, mixing, chat, HTML, packing, toxicity."""
