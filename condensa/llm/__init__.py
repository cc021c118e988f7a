"""Training-data operators: dedup, language id, chat formatting, mixing, extraction, decontamination."""
