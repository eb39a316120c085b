"""Registry of the profile-alignment queries and their SQL equivalents."""

from weft.plans import alignments, relational


def queries():
    return {**relational.QUERIES, **alignments.QUERIES}


def oracle_sql():
    return {**relational.ORACLE, **alignments.ORACLE}
