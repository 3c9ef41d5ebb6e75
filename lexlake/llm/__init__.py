"""Operations of a training-data pipeline over documents and web pages.

Nothing outside this subpackage imports it.
"""
