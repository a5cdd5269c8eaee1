"""Training-data operators: search, language ID, licences, toxicity, media, HTML, tokens, packing, joins."""
