"""Training-data operators: dedup, decontamination, filtering, formatting and mixing of text corpora.

Nothing outside this subpackage imports it. Common rules, unless an operator says otherwise: a null text has no words and no lines; null ids
are kept and treated as one more id value; rows equal in id and text are repeated rows of one document and get equal results; extra columns of
the input are carried in one struct, so their names cannot clash with those used inside.
"""
