"""Named transforms over relations: the registry with all operators in it, chains, kept results, resolvers."""
