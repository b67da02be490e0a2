"""Operators of a training-data pipeline: cleaning, language, licences, HTML, URLs,
personal data, near-duplicates, tokens, decontamination, repeated byte strings.

Nothing else in the library imports this subpackage.  Every operator reads only
the columns it names, so further columns of a table, clashing names included,
never reach its internals.
"""
