"""Where rows come from and go to: Parquet tables, versioned tables, entity models in XML."""
