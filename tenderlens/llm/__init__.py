"""Training-data operators: dedup, quality, toxicity, extraction, tokens, mixing, chats, neighbours, secrets."""
