"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` registers the ``opN_<name>`` queries and their SQL.
"""
