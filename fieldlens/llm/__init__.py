"""Training-data operators: decontamination, toxicity, line dedup, language ID, exact search,
secret scans, mixing, web archives, chat formatting, near-duplicate removal, language-model scores, spelling variants
and tokenizer alignment."""
