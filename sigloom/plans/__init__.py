"""Jobs made of operators: evaluation, pipelines."""
