"""Named plans: each operator as a query over the tables of a folder, with the SQL it must agree with."""
