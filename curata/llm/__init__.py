"""Training-data operators: quality, media, mixing, chat, near-duplicates, licences, PII, secrets, BPE, exact search, clustering, token counts and whitening."""
