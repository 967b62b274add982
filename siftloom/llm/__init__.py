"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  ``queries()`` and
``oracle_sql()`` list its registered queries.
"""

from __future__ import annotations


def queries():
    from . import registry

    return registry.queries()


def oracle_sql():
    from . import registry

    return registry.oracle_sql()
