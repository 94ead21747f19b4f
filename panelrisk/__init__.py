"""panelrisk: entity-by-period risk panels as lazy PySpark DataFrame operators."""
