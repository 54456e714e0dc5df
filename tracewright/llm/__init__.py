"""Training-data operators on Spark: packing, chat, HTML, near-duplicates, language model, decontamination,
personal data, line duplicates, quality and toxicity. Nothing outside this subpackage imports it."""
