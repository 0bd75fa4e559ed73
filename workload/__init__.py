"""The registered queries over the order-warehouse tables, each beside the SQL that checks it."""
