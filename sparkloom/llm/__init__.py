"""Training-data operators: deduplication, decontamination, extraction, labelling, search, scanning and mixing.

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds its queries when it is present.
"""
