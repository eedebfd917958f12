"""Jobs made of operators: tier policy, refresh, retention, history, and the query registry."""
