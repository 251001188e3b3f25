"""Sources: public-record files as canonical tables. Every reader has an explicit schema and keeps going past bad records."""
