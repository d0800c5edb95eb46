"""What frames of flat records can do: predicates, column filters, frames."""
