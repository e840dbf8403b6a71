"""A PySpark engine for facts (subject, relation, object): conjunctive queries, statistics, Horn-rule mining, prediction."""
