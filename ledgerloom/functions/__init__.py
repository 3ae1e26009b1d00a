"""Pure ``Column -> Column`` helpers; everything stays inside codegen."""
