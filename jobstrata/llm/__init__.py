"""Training-data preparation operators.

Nothing outside this subpackage imports it.  ``queries`` holds the thin
``opN_<name>`` entry points, every other module one operator.
"""
