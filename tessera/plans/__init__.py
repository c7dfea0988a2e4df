"""The registered queries of the library: name -> (query, SQL twin or None)."""

from tessera.plans import browse, cast, change, documents, fields, intake, lists, parsing, publish, relational, stats, texts

QUERIES = browse.QUERIES | stats.QUERIES | relational.QUERIES | texts.QUERIES | change.QUERIES | fields.QUERIES | publish.QUERIES | lists.QUERIES | documents.QUERIES | cast.QUERIES | parsing.QUERIES | intake.QUERIES
