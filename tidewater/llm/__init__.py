"""Training-data operators: secrets, packing, languages, near copies, quality,
nearest neighbours, byte-level BPE, licences and token counts."""
