"""Evidence-grounded analytics over text, graphs and event ledgers, as Spark DataFrame operators."""
