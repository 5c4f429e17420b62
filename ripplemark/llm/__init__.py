"""Operators for corpora of text: tokenizer encoding, leaked evaluation texts, text quality. Nothing else imports this."""
